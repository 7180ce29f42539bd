"""loomgrid.sources"""
