"""evigraph.sources"""
