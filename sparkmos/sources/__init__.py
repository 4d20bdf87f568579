"""Raw payload tables to forecast, observation and climatology rows."""
