"""Relational operators over column roles: entity, key, seq, start, end, value.

``seq`` is the order in which events were dispatched; every first-N cap and every first or latest value follows it.

Operators take column names and add columns of their own. A column of the input that has the name of an added one is
replaced; names that begin with an underscore belong to the operators, and inputs do not use them. Null keys form a
group of their own in windows and match nothing in joins, unless an operator says otherwise; empty tables give empty
results, and repeated rows count as often as they are there.
"""
