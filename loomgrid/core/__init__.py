"""loomgrid.core"""
