"""watchwell.sources"""
