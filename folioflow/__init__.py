"""folioflow: a document-pipeline engine on Spark DataFrames.

Books, web pages and plain documents become an ordered table of text units
with stable keys; the units are normalised, filtered, packed, transformed by a
pluggable engine, checkpointed and joined back into ordered output.
"""

__version__ = "0.1.0"
