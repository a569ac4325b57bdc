"""Case-trajectory analytics as DataFrame-to-DataFrame functions."""
