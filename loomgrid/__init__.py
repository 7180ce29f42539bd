"""loomgrid: dense-array algebra, measurement and data preparation as Spark DataFrame plans."""
