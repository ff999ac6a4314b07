"""evigraph.operators"""
