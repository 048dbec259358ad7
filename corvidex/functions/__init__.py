"""corvidex: functions."""
