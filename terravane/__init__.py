"""Access analytics on Spark: who can reach what, how far, and how many."""
