"""loomtext.operators"""
