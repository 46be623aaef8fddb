"""Column functions: tags, maps, text, time and geometry.  Catalyst expressions but for ``geo.utm_area``, an Arrow UDF over whole batches."""
