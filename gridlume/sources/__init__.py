"""Readers and writers: landed JSON, place directories, keyed tables with expiry, GeoJSON."""
