"""loomtext.plans"""
