"""loomtext.llm"""
