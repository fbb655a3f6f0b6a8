"""How the tables become pairs and anchors, the queries over them, and SQL for each."""
