"""Operators of a training-data pipeline: deduplication, decontamination, scoring, mixing, search, formatting, archives.

Nothing else in the library imports this subpackage.  Conventions shared by all operators:

* ``text`` null counts as the empty text; extra columns of the input are ignored by operators that
  return a result table and passed through by the pipeline stages.
* Rows that repeat the same id and the same text count as one document and get the same result;
  rows with the same id and different texts are separate documents.  A null id sorts before every other.
* Empty tables give empty results with the same schema.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (``common.stored``).
"""
