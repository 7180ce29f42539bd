"""loomgrid.plans"""
