"""Where the data is: the dataset catalogue and the file footers."""
