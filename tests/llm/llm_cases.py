"""Odd texts and small helpers of the text operators' tests."""

import re
import string

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# Nulls, empty and blank texts, ties, repeated rows, and columns whose names clash with results.
EDGES = [None, "", " \n\t ", "one", "Two  words", "Two words", "İstanbul ß é 日本 🙂", "\0 nul \0", "a\x85b c", "x" * 5_000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
