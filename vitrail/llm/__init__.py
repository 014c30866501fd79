"""Training-data operators (dedup, packing, language ID, quality, archives).

Nothing outside this subpackage imports it; ``vitrail.llm.queries`` holds the
registered queries and their SQL.
"""
