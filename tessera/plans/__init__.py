"""Planning on the driver, from descriptors alone."""
