"""domlake.sources"""
