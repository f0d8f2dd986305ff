"""domlake.plans"""
