"""Functions of the transcript, feed and release library."""
