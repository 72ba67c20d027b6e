"""Column expressions and generated calendars."""
