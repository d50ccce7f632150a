"""Query front-ends over graph views: SQL, and subsets of Cypher and Gremlin."""
