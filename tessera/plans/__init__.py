"""Cross-cutting helpers: staged tables, size checks, cost reports, the SQL gate."""
