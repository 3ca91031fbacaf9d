"""watchwell.plans"""
