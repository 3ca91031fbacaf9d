"""watchwell.operators"""
