"""glossmill.streaming"""
