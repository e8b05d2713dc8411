"""talkloom.functions"""
