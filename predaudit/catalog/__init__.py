"""The registered queries over the test tables and their reference SQL."""
