"""Where quads come from and go to."""
