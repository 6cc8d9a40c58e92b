"""Operators for preparing language-model training data.

Each module holds one operator with a general ``DataFrame -> DataFrame``
interface; :mod:`waymark.llm.queries` derives the registered ``opN_*`` results
from them. Nothing outside this subpackage imports it.
"""
