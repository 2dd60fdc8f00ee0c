"""Operators that prepare text corpora for language-model training.

Every operator takes a DataFrame of documents and works on whole texts.  Shared rules:

* a null text counts as empty; null ids are legal and kept;
* a row is identified by ``(doc_id, hash of its text)``, so rows repeated in full count as one document and get one answer each;
* only the named columns are read, so extra columns, whatever their names, pass through or are left out but never clash;
* an empty table gives an empty result with the same columns.
"""
