"""Reading and writing designs, spectra, registries and reports."""
