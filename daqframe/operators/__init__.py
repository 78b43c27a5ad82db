"""DataFrame operators on log data: windows, bit fields, time, layout, symbols, checks and clocks."""
