"""DuckDB SQL that states what each catalogue query has to return."""
