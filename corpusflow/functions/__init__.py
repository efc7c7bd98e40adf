"""Column functions: text cleaning, Unicode, tools."""
