"""loomgrid.functions"""
