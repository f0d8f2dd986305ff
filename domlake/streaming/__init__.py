"""domlake.streaming"""
