"""See README: functions."""
