"""Operators for preparing large text corpora for training.

Each module holds one operator with its own interface; ``queries`` registers
one query per operator.  Nothing else in the library imports this package.
"""
