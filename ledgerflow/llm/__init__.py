"""Training-data operators: quality, near duplicates, licences, decontamination,
packing, token files, token counts, chat formatting and personal data.

Each module holds one operator with its general interface; ``queries`` binds them
to the test tables. Nothing outside this package imports it.
"""
