"""End products: the frames behind every figure and table of a study."""
