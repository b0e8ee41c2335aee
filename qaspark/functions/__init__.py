from qaspark.functions.text import py_lower_strip, py_strip, py_words, word_count

__all__ = ["py_lower_strip", "py_strip", "py_words", "word_count"]
