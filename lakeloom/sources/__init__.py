"""Reading nodes, contents and logs; writing embeddings and tables."""
