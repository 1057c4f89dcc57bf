"""Static dataflow analysis of PHP plugins."""
