"""Training-data operators: deduplication, quality, personal data, URL
reputation, decontamination, chat formatting, tokenisation and license scans.

Nothing outside this subpackage imports it, apart from the guarded
registration in ``__spark_entry__.py`` and the pipeline built on it.
"""
