"""glossmill: bilingual-lexicon and reading-practice analytics on PySpark DataFrames."""
