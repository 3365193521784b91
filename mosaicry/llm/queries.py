"""The modules of this package that hold queries."""

from mosaicry.llm import queries_mixing, queries_names, queries_records, queries_speech, queries_text, queries_vectors

MODULES = [queries_mixing, queries_names, queries_records, queries_speech, queries_text, queries_vectors]
