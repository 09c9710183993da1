"""Operators for preparing training corpora: one module per operator, each a set of
DataFrame-to-DataFrame functions, plus ``queries`` with the thin registered queries."""
