"""evigraph.plans"""
