"""Where facts come from: files, projects, tables and JavaScript text."""
