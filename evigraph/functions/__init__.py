"""evigraph.functions"""
