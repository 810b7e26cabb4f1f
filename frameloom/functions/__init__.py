"""frameloom.functions"""
