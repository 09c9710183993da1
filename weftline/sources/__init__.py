"""Reading, writing and generating matrices."""
