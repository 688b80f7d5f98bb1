"""The registered queries, each next to the SQL that must give the same rows."""

from catalog import client, documents, events, search, streams

GROUPS = (documents, search, events, client, streams)
