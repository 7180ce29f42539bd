"""Row-local text operators against brute force, with the cases that each defines."""

import base64
import collections
import hashlib
import re
import zlib

import public_tokenizers
import pytest

from loomgrid.llm import bpe, chat, license, oracles, packing, quality, queries, tokencount
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
RANKS, MERGES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " \n\t ", "of of\x0cof", "one", "A b c d e f g h i j\nA b c d e f g h i j", "x" * 700 + " y", " " * 500 + "z", "don't we'll  ok\n\n fin",
    "héllo wörld ñandú 123 ² ½", "MIT License and the GNU General Public License; cc by", "Licensed under the great Apache License, Version 2.0.", "😀 " * 40, "<|endoftext|> a",
    "Home | News | About | Contact | More\nThe rest is a text of one line that has more than ten words in it, all unlike.", "a\u0000b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", "clash"), (None, "null id", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, quality string")


def empty(docs):
    return docs.limit(0)


def test_quality_counts(docs):
    got = quality.assess(docs).select("doc_id", "text", "words", "quality.*").collect()
    assert len(got) == docs.count()
    for r in got:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality.assess(empty(docs)).count() == 0
    nav = next(r for r in got if r.text and r.text.startswith("Home"))
    assert nav.kept and nav.clean_text.startswith("The rest")


def test_license_places(docs):
    got = {r.doc_id: r for r in license.scan_licenses(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, x.label) for x in license.BASE for p in range(len(w)) if w[p : p + len(x.words.split())] == x.words.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), t
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert "apache" in got[11].labels  # a word was put into the notice
    assert license.scan_licenses(empty(docs)).count() == 0


@pytest.mark.parametrize("kind", ["ranks", "merges"])
def test_bpe_is_that_of_the_public_libraries(docs, kind):
    path = RANKS if kind == "ranks" else MERGES
    if kind == "ranks":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = lambda x: t.encode(x, add_special_tokens=False).ids
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, kind=kind)
    for r in ids.join(docs, "doc_id").collect():
        assert r.ids == want(r.text or "")
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(ids, path, public_tokenizers.PATTERN, kind=kind).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
    for r in bpe.digest(docs, path, public_tokenizers.PATTERN, kind=kind).filter("doc_id < 20").collect():
        x = want(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(empty(docs), path, public_tokenizers.PATTERN, kind=kind).count() == 0


def test_token_counts_against_plain_dp(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = tokencount.Unigram.from_ranks(path, public_tokenizers.PATTERN)

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            best.append(min((best[s][0] - model.scores[word[s:e]], best[s][1] + 1) for s in range(max(0, e - model.longest), e) if word[s:e] in model.scores))
        return best[-1]

    got = {r.doc_id: r for r in tokencount.count_tokens(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        pre = model.find(t or "")
        assert got[i].n_pre_tokens == len(pre)
        if max(map(len, pre), default=0) < 60:
            assert got[i].n_tokens == sum(plain(p.encode())[1] for p in pre)
    assert tokencount.count_tokens(empty(docs), path, public_tokenizers.PATTERN).count() == 0


def test_chat_round_trip_and_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<b [x] \\"), (1, 2, "assistant", "ok</s>"), (2, 0, "assistant", None), (3, 0, "tool", "[INST] t"), (3, 1, None, "n"), (3, 1, None, "n"), (None, None, "user", ""), (4, 0, "user", "[REPLY] [/TURN]<\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.digest_chats(made).collect()}
    for c in (1, 2, 3, 4, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        said = "".join(f"{a}\n{b}\n" for a, b in own)
        loss = "".join(b for a, b in own if a == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, False, False, False]
    assert made.filter("formatted LIKE '%ok</s>%'").count() == 0
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_packing_pieces(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MERGES)
    got = packing.pack_documents(docs.filter("doc_id <> 3"), MERGES, public_tokenizers.PATTERN, capacity=64).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, x in enumerate(TEXTS):
        if i == 3:
            continue
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        at = 0
        for p, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at) and (p == 0 or r.length == 64)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part))
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), MERGES, public_tokenizers.PATTERN).count() == 0


def test_small_packings_are_optimal():
    import random

    def best(items, cap):
        items, low = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return low[0]

    random.seed(1)
    for _ in range(60):
        cap = random.choice([10, 20, 50])
        items = [random.randint(1, cap) for _ in range(random.randint(1, 10))]
        assert sum(n for _, n in packing.complete_bins(dict(collections.Counter(items)), cap)) == best(items, cap)


@pytest.mark.parametrize("name", ["op1_license_scans", "op6_quality_rules", "op8_chat_formatting"])
def test_same_as_sql(spark, name):
    assert oracles
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_licenses_of_repeated_ids_and_chained_diagonals(spark):
    chained = "gnu lesser " * 8 + "gnu lesser general public license"
    rows = [(1, chained), (None, "cc by"), (None, "apache license"), (7, "mit license"), (7, "x x mit license"), (8, None), (9, "word " * 200_000 + "mit license")]
    got = [(r.doc_id, r.n_words, r.n_base, r.labels) for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 21, 0, "lgpl"), (None, 2, 1, "cc-by"), (None, 2, 1, "apache"), (7, 2, 1, "mit"), (7, 4, 1, "mit"), (8, 0, 0, ""), (9, 200_002, 1, "mit")]
    assert sorted(got, key=str) == sorted(want, key=str)
