"""domlake.functions"""
