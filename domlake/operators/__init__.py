"""domlake.operators"""
