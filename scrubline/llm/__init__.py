"""Training-data operators: each is a DataFrame function, with thin queries in ``queries.py``.

Shared rules, stated once. Rows with a null identifier take part and keep the null. A null text
counts as empty. Repeated rows are separate rows. Only the named input columns are read, and results
hold only the columns their docstring lists, so further columns with clashing names do no harm.
"""
