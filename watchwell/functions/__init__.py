"""watchwell.functions"""
