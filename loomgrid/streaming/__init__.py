"""loomgrid.streaming"""
