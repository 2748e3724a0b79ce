"""All registered queries of the catalog operators, with their SQL."""

from . import q_catalog, q_files, q_history, q_incoming, q_json, q_listings, q_more, q_rest, q_streams, q_tables, q_validation, q_values

_ALL = {**q_values.Q, **q_catalog.Q, **q_more.Q, **q_rest.Q, **q_streams.Q, **q_listings.Q, **q_history.Q, **q_tables.Q, **q_incoming.Q, **q_validation.Q, **q_files.Q, **q_json.Q}

QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
