"""watchwell.streaming"""
