"""Operations of a training-data pipeline: near-duplicate search, packing, language
identification, mixing, URL and secret filters, and binary and media outputs.

Nothing outside this subpackage imports it.
"""
