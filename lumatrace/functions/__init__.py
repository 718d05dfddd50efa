"""functions of the imaging and behaviour library."""
