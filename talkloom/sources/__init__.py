"""talkloom.sources"""
