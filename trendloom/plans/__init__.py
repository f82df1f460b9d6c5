"""Composed query plans: the product's API queries, procedures and views,
the stand-in fixtures over the driver tables, and the query registry."""
