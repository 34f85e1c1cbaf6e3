"""loomgrid: transit-network analytics and corpus preparation as Spark DataFrame plans."""
