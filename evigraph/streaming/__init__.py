"""evigraph.streaming"""
