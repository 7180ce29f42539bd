"""loomgrid.operators"""
