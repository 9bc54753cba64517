"""sheetscope: profile, relate and summarise folders of tables on Spark."""
