"""Schemas of the data model. Missing data (ignore values, NaN, bad bands) is NULL everywhere."""

GEOTRANSFORM = "struct<gt0:double,gt1:double,gt2:double,gt3:double,gt4:double,gt5:double>"
DATASETS = f"ds_id long, name string, width int, height int, num_bands int, ignore_value double, gt {GEOTRANSFORM}, wkt string"
BANDS = "ds_id long, band int, description string, wavelength double, unit string, good boolean"
PIXELS = "ds_id long, y int, x int, spectrum array<double>"
SPECTRA = "spec_id long, name string, library string, unit string, wavelengths array<double>, values array<double>, good array<boolean>"
ROI_PIXELS = "roi_id long, x int, y int"
MATCHES = "ds_id long, y int, x int, ref_id long, score double, scale double, is_match boolean"
