"""Operators for preparing training data at scale.

Nothing outside this folder imports it; its queries are listed in
``evenkeel.llm.queries``.
"""
