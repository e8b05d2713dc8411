"""talkloom.plans"""
