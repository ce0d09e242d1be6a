"""Column functions: unit and text conversion, schedules, scores and losses."""
