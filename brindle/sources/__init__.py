"""Tables, indexes and scans."""
