"""Reading folders of tables and editing stored tables."""
