"""Operators for building training corpora: dedup, filtering, scoring and packing.

Nothing else in the library imports this subpackage. Each operator module has a
general function on DataFrames plus the thin ``opN_*`` query that applies it to
the whole table; :mod:`histora.llm.registry` lists the queries.

Conventions shared by every operator here:

* input columns are taken by name, so extra columns are ignored, whatever they
  are called;
* a null text counts as empty text; a null ``doc_id`` sorts after every other
  id and comes back as null;
* an empty table gives an empty result with the full schema.
"""
