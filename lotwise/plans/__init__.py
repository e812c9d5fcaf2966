"""All queries over the star tables, by name, and the SQL they are held against."""
